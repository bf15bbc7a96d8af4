"""longomics: RNA-seq count-matrix analytics as Spark DataFrame operators on long tables."""
