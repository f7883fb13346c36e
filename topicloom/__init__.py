"""Topic-modelling analytics on Spark: corpus preparation, training, evaluation, reports."""
