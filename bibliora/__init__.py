"""Analytics over corpora of scholarly papers, written as Spark DataFrame plans."""
