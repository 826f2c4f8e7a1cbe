"""corvane: dataset preparation and assessment as PySpark DataFrame programs."""
