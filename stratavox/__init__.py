"""stratavox: volumetric grid analytics, tile catalogues and corpus processing on Spark."""
