"""Reading requests and responses, writing responses, events, manifests and reports."""
