"""leafmill: document, worksheet and scanned-page analytics on PySpark."""
