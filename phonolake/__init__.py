"""phonolake: acoustic and corpus analytics expressed as Spark DataFrame plans."""
