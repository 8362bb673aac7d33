"""Trust analytics for geo-tagged reports, written for Spark."""
