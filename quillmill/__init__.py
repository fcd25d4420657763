"""quillmill: cleaning, features and corpus jobs for text tables, as Spark plans."""
