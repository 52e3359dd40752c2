"""Page-oriented document analytics on Spark."""
