"""seqloom: sequence, interval and rectangle analytics as Spark DataFrame plans."""
