"""Content measurement and curation on Spark: DataFrame-to-DataFrame functions over tables."""
