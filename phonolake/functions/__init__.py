"""phonolake subpackage."""
