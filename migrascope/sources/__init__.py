"""Where files come from: directory trees, path lists, change streams, and the TypeScript reader."""
