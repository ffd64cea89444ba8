"""Where records come from and go to: snapshot tables, exports, schema files."""
