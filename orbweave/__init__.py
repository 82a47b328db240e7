"""orbweave: graph analytics and data preparation written for Apache Spark."""
