"""Document extraction, validation and routing on PySpark; see README.md."""
