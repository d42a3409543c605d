"""framespark: Spark jobs for microscope frames of integrated circuits and the tables derived from them."""
