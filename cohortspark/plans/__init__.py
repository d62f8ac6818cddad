"""End-to-end cohort compositions and the query registry."""
