"""Notice analytics on Spark: DataFrame operators over corpora of official notices."""
