"""Reading the tables and the nested thread documents, and writing results."""
