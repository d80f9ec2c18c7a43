"""Sources and sinks of documents, records and reports."""
