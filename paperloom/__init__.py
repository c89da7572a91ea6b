"""paperloom: scholarly-document analytics expressed as Spark DataFrame plans."""
