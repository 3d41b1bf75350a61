"""Sources and sinks: adapters over tables, OTLP and native JSON, generated scenarios, the span store."""
