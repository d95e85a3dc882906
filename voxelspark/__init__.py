"""voxelspark: labelled image volumes and their region graphs as Spark DataFrames."""
