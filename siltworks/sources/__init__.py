"""sources of the curation engine."""
