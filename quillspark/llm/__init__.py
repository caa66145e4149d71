"""Training-data operators. Nothing else in quillspark imports this subpackage."""
