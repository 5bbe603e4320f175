"""A PySpark engine for machine-readable zones of travel documents."""
