"""Statement files, and adapters from star-schema tables to the domain."""
