"""docloom: document retrieval, text structuring and corpus preparation on PySpark."""
