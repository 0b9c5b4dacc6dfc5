"""docketry: document-verification analytics and training-data preparation on Spark DataFrames."""
