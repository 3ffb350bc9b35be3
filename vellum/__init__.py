"""vellum: analytics over recognised document pages, declared as Spark DataFrames."""
