"""Web page snapshots to clean, validated, deduplicated records, as Spark plans."""
