"""Tables in the shared folder, and the registered queries."""
