"""Where units and codes come from."""
