"""Plan rewrites above Catalyst: ordered operations without one global task."""
