"""textloom: a Spark-first engine that builds and analyses language-model text corpora."""
