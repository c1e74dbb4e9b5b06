"""graphloom: graph learning and corpus analytics as Spark DataFrame dataflow."""

__version__ = "0.1.0"
