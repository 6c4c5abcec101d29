"""The public queries: operators composed over whole tables."""
