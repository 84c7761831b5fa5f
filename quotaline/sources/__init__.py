"""Raw entities: declared schemas, landing folders and the star-schema mapping."""
