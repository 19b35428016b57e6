"""The same windows on streams. The reference data model has no streams; this is an extension."""
