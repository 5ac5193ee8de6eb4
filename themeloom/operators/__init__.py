"""The steps of the model, each from DataFrames to DataFrames."""
