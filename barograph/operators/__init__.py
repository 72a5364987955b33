"""DataFrame to DataFrame operators over keyed panels."""
