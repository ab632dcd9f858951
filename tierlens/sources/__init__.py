"""Sources and sinks: dimensions, request-log and failure tables, model store, provider payloads."""
