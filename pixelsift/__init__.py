"""pixelsift: image and payload forensics, and corpus building, as plain Spark plans."""
