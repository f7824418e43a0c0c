"""From mapping configuration to column expressions."""
