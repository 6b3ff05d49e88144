"""plans of the curation engine."""
