"""DataFrame operators: bracket levels and nodes. by names the columns that identify a document."""
