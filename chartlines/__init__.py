"""chartlines: Spark jobs on line segments, axes, pixels and the tables behind charts."""
