"""Parcel and address analytics on Spark DataFrames."""
