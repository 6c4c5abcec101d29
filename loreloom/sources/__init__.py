"""Tables, files and payloads in; tables and JSON out."""
