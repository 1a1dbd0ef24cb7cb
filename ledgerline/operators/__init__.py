"""DataFrame operators over scripts, state, facts and table rows."""
