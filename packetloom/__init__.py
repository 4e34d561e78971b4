"""packetloom: network-detection analytics as plain Spark DataFrame transformations."""
