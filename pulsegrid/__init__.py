"""pulsegrid: a Spark-first engine for blood-flow imaging signals and corpora."""
