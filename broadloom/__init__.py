"""broadloom: prepare very wide tables on Spark and choose features from them."""
