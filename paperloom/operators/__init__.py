"""The document-intake operations as DataFrame transformations."""
