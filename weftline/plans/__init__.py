"""Plan-level helpers shared by the operators: shared scratch tables and graph closures."""
