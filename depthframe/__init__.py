"""depthframe: order-book analytics as Spark DataFrame operators."""
