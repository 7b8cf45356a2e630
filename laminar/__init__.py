"""Analytics over gridded surface meshes, expressed as Spark DataFrame programs."""
