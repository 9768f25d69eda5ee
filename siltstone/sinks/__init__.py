"""Writers: tables, graph files, reports and evidence packages."""
