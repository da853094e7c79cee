"""Sources and sinks: workspaces, diagnostics of external tools, symbols of source files, reports."""
