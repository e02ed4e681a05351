"""graintable: Spark DataFrame operators for document collections and the measurements taken from them."""
