"""Documents from files: dispatch by extension, validation, and conversion to Markdown."""
