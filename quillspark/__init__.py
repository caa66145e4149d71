"""quillspark: text-retrieval, graph, recommendation and corpus analytics on Spark DataFrames."""
