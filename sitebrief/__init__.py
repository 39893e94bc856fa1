"""Company intelligence over crawled web pages, as Spark DataFrame operators."""
