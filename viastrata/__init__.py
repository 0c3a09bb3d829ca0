"""Road-network, raster and corpus analytics as PySpark DataFrame operators."""
