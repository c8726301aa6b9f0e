"""Tables in and out: hardened CSV, row ids and sinks."""
