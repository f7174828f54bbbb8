"""lectern: document-library and speech-preparation operators on Spark DataFrames."""
