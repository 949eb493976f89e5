"""Query model, profiles, plug-ins and the search plan."""
