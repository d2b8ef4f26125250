"""Discovery of downloadable geospatial data sets in web pages, as Spark jobs."""
