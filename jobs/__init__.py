"""Jobs on the page index: each has run(spark, ...) and a command line."""
