"""From dialect text to a Spark plan: parser, syntax tree and compiler."""
