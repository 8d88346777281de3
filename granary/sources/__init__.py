"""Sources and sinks; paths go to Spark, so any file system it knows will do."""
