"""tideframe: conversational-stream and corpus analytics on PySpark DataFrames."""
