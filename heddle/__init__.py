"""heddle: Spark-native analytics over fetched pages, ranked results, threads and their logs."""
