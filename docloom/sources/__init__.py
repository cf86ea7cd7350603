"""Where rows come from and go to: Parquet tables, files of documents, sinks."""
