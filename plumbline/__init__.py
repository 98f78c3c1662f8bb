"""A claim-graph engine on Spark: documents as relations, checked and walked with DataFrames."""
