"""Column functions: expressions that stay inside the JVM, unless their docstring says otherwise."""
