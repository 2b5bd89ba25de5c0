"""leafmill: saved web pages to scored, structured records, as Spark jobs."""
