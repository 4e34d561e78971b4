"""Sources and sinks: rules, indicators, packets, signatures, alert logs and tables."""
