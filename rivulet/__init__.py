"""A change-data-capture and document-materialisation engine on Spark DataFrames."""
