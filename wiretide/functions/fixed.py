"""Names, ports, ranges and patterns that decide results, in their natural order."""

# Service names by port.
TCP_SERVICES = {
    20: "FTP-Data", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 43: "WHOIS", 53: "DNS", 79: "Finger", 80: "HTTP", 88: "Kerberos",
    110: "POP3", 111: "RPC", 113: "Ident", 119: "NNTP", 135: "MSRPC", 137: "NetBIOS-NS", 138: "NetBIOS-DGM", 139: "NetBIOS-SSN",
    143: "IMAP", 161: "SNMP", 179: "BGP", 389: "LDAP", 443: "HTTPS", 445: "SMB", 465: "SMTPS", 500: "ISAKMP", 512: "rexec",
    513: "rlogin", 514: "syslog", 515: "LPD", 543: "klogin", 544: "kshell", 548: "AFP", 554: "RTSP", 587: "SMTP-Sub",
    593: "MSRPC-HTTP", 623: "IPMI", 636: "LDAPS", 873: "rsync", 990: "FTPS", 993: "IMAPS", 995: "POP3S", 1080: "SOCKS",
    1194: "OpenVPN", 1433: "MSSQL", 1521: "Oracle", 1723: "PPTP", 1883: "MQTT", 2049: "NFS", 2082: "cPanel", 2375: "Docker",
    2376: "Docker-TLS", 3128: "Squid", 3268: "LDAP-GC", 3306: "MySQL", 3333: "Stratum", 3389: "RDP", 3690: "SVN", 4444: "Metasploit",
    4445: "Stratum", 4789: "VXLAN", 5000: "UPnP", 5432: "PostgreSQL", 5555: "ADB", 5601: "Kibana", 5900: "VNC", 5985: "WinRM",
    5986: "WinRM-TLS", 6379: "Redis", 6667: "IRC", 7001: "WebLogic", 8000: "HTTP-Alt", 8008: "HTTP-Alt", 8080: "HTTP-Proxy",
    8081: "HTTP-Alt", 8088: "HTTP-Alt", 8443: "HTTPS-Alt", 8888: "HTTP-Alt", 9000: "HTTP-Alt", 9001: "Tor-OR", 9030: "Tor-Dir",
    9050: "Tor-SOCKS", 9200: "Elasticsearch", 9300: "Elasticsearch", 10000: "Webmin", 11211: "Memcached", 14444: "Stratum",
    27017: "MongoDB", 45560: "Stratum",
}
UDP_SERVICES = {
    53: "DNS", 67: "DHCP", 68: "DHCP", 69: "TFTP", 88: "Kerberos", 123: "NTP", 137: "NetBIOS-NS", 138: "NetBIOS-DGM", 161: "SNMP",
    162: "SNMP-Trap", 389: "LDAP", 443: "QUIC", 500: "ISAKMP", 514: "syslog", 520: "RIP", 623: "IPMI", 1194: "OpenVPN",
    1900: "SSDP", 3478: "STUN", 4500: "IPsec-NAT", 4789: "VXLAN", 5060: "SIP", 5353: "mDNS", 5355: "LLMNR", 6081: "Geneve",
    51820: "WireGuard",
}

# Ports whose services carry content in the clear, that serve remote access, mining pools, Tor and VPNs.
CLEARTEXT_SERVICES = {21: "FTP", 23: "Telnet", 25: "SMTP", 69: "TFTP", 80: "HTTP", 110: "POP3", 143: "IMAP", 161: "SNMP", 389: "LDAP", 512: "rexec", 513: "rlogin", 514: "syslog"}
LATERAL_SERVICES = {22: "SSH", 135: "MSRPC", 139: "NetBIOS-SSN", 445: "SMB", 3389: "RDP", 5900: "VNC", 5985: "WinRM", 5986: "WinRM-TLS"}
MINING_PORTS = (3333, 4444, 4445, 5555, 7777, 8888, 14444, 45560, 45700)
TLS_PORTS = (443, 465, 587, 636, 990, 993, 995, 8443)
TOR_PORTS = (9001, 9030, 9050, 9051, 9150)
VPN_PORTS = {500: "IKE/IPsec", 1194: "OpenVPN", 1701: "L2TP", 1723: "PPTP", 4500: "IPsec NAT-T", 51820: "WireGuard"}
TOR_AUTHORITIES = (
    "128.31.0.39", "86.59.21.38", "194.109.206.212", "131.188.40.189", "193.23.244.244",
    "171.25.193.9", "154.35.175.225", "199.58.81.140", "204.13.164.118", "66.111.2.131",
)

# Reserved ranges (range, name, purpose), first match wins.
SPECIAL_RANGES = (
    ("0.0.0.0/8", "This network", "reserved"),
    ("10.0.0.0/8", "Private network", "private"),
    ("100.64.0.0/10", "Carrier-grade NAT", "cgnat"),
    ("127.0.0.0/8", "Loopback", "loopback"),
    ("169.254.0.0/16", "Link-local", "link-local"),
    ("172.16.0.0/12", "Private network", "private"),
    ("192.0.2.0/24", "Documentation", "documentation"),
    ("192.168.0.0/16", "Private network", "private"),
    ("198.18.0.0/15", "Benchmark testing", "reserved"),
    ("198.51.100.0/24", "Documentation", "documentation"),
    ("203.0.113.0/24", "Documentation", "documentation"),
    ("224.0.0.0/4", "Multicast", "multicast"),
    ("240.0.0.0/4", "Reserved", "reserved"),
    ("fc00::/7", "Unique local", "private"),
    ("fe80::/10", "Link-local", "link-local"),
    ("ff00::/8", "Multicast", "multicast"),
    ("2001:db8::/32", "Documentation", "documentation"),
)
#: IPv4 ranges that count as internal.
PRIVATE_RANGES = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)

# Ranges of known operators (range, operator, category), first match wins.
KNOWN_NETWORKS = (
    ("8.8.8.0/24", "Google Public DNS", "dns"),
    ("8.8.4.0/24", "Google Public DNS", "dns"),
    ("1.1.1.0/24", "Cloudflare DNS", "dns"),
    ("1.0.0.0/24", "Cloudflare DNS", "dns"),
    ("9.9.9.0/24", "Quad9 DNS", "dns"),
    ("208.67.222.0/24", "OpenDNS", "dns"),
    ("208.67.220.0/24", "OpenDNS", "dns"),
    ("13.32.0.0/15", "Amazon CloudFront", "cdn"),
    ("13.64.0.0/11", "Microsoft Azure", "cloud"),
    ("20.0.0.0/8", "Microsoft Azure", "cloud"),
    ("40.64.0.0/10", "Microsoft Azure", "cloud"),
    ("52.0.0.0/8", "Amazon AWS", "cloud"),
    ("54.0.0.0/8", "Amazon AWS", "cloud"),
    ("3.0.0.0/9", "Amazon AWS", "cloud"),
    ("18.192.0.0/11", "Amazon AWS", "cloud"),
    ("34.64.0.0/10", "Google Cloud", "cloud"),
    ("35.184.0.0/13", "Google Cloud", "cloud"),
    ("104.16.0.0/12", "Cloudflare", "cdn"),
    ("172.64.0.0/13", "Cloudflare", "cdn"),
    ("162.158.0.0/15", "Cloudflare", "cdn"),
    ("151.101.0.0/16", "Fastly", "cdn"),
    ("199.232.0.0/16", "Fastly", "cdn"),
    ("23.32.0.0/11", "Akamai", "cdn"),
    ("104.64.0.0/10", "Akamai", "cdn"),
    ("157.240.0.0/16", "Meta", "service"),
    ("31.13.24.0/21", "Meta", "service"),
    ("140.82.112.0/20", "GitHub", "service"),
    ("185.199.108.0/22", "GitHub Pages", "service"),
    ("45.32.0.0/12", "Vultr", "vps"),
    ("45.76.0.0/14", "Vultr", "vps"),
    ("45.77.0.0/16", "Vultr", "vps"),
    ("64.176.0.0/12", "Vultr", "vps"),
    ("104.238.128.0/17", "Vultr", "vps"),
    ("159.65.0.0/16", "DigitalOcean", "vps"),
    ("165.227.0.0/16", "DigitalOcean", "vps"),
    ("167.71.0.0/16", "DigitalOcean", "vps"),
    ("134.209.0.0/16", "DigitalOcean", "vps"),
    ("128.199.0.0/16", "DigitalOcean", "vps"),
    ("139.59.0.0/16", "DigitalOcean", "vps"),
    ("172.104.0.0/15", "Linode", "vps"),
    ("139.162.0.0/16", "Linode", "vps"),
    ("45.79.0.0/16", "Linode", "vps"),
    ("176.9.0.0/16", "Hetzner", "vps"),
    ("116.202.0.0/15", "Hetzner", "vps"),
    ("144.76.0.0/16", "Hetzner", "vps"),
    ("51.15.0.0/16", "Scaleway", "vps"),
    ("163.172.0.0/16", "Scaleway", "vps"),
    ("51.75.0.0/16", "OVH", "vps"),
    ("54.36.0.0/16", "OVH", "vps"),
    ("91.121.0.0/16", "OVH", "vps"),
    ("185.220.100.0/22", "Tor exit relays", "anonymity"),
    ("185.220.96.0/22", "Tor relays", "anonymity"),
    ("199.249.230.0/24", "Quintex / Tor", "anonymity"),
    ("171.25.193.0/24", "DFRI / Tor", "anonymity"),
    ("45.15.156.0/22", "Bulletproof hosting", "suspicious"),
    ("194.26.29.0/24", "Bulletproof hosting", "suspicious"),
    ("5.188.206.0/24", "Bulletproof hosting", "suspicious"),
)

# IPv6 ranges of known operators (range, operator, category), first match wins.
KNOWN_NETWORKS_V6 = (
    ("2606:4700::/32", "Cloudflare", "cdn"),
    ("2001:4860::/32", "Google", "cloud"),
    ("2600:1f00::/24", "Amazon AWS", "cloud"),
    ("2620:1ec::/36", "Microsoft", "cloud"),
    ("2a03:2880::/32", "Meta", "service"),
    ("2001:678::/29", "RIPE allocation", "registry"),
)
# Registries by the first number of an IPv4 address (from, to), first match wins, and by the first group of an IPv6 one.
REGISTRIES = {
    "ARIN": ((3, 3), (4, 4), (6, 9), (11, 24), (26, 26), (28, 30), (32, 35), (38, 38), (40, 40), (44, 45), (47, 48), (50, 50), (52, 56), (63, 76), (96, 100), (104, 108), (128, 129), (130, 132), (134, 137), (139, 140), (142, 144), (146, 148), (152, 152), (155, 162), (164, 174), (184, 184), (192, 192), (198, 199), (204, 209), (216, 216)),
    "RIPE": ((2, 2), (5, 5), (25, 25), (31, 31), (37, 37), (46, 46), (51, 51), (57, 57), (62, 62), (77, 95), (109, 109), (141, 141), (145, 145), (149, 149), (151, 151), (176, 178), (185, 188), (193, 195), (212, 213), (217, 217)),
    "APNIC": ((1, 1), (14, 14), (27, 27), (36, 36), (39, 39), (42, 43), (49, 49), (58, 61), (101, 103), (110, 126), (133, 133), (150, 150), (153, 153), (163, 163), (171, 171), (175, 175), (180, 183), (202, 203), (210, 211), (218, 223)),
    "LACNIC": ((179, 179), (181, 181), (186, 191), (200, 201)),
    "AFRINIC": ((41, 41), (102, 102), (105, 105), (154, 154), (196, 197)),
}
REGISTRIES_V6 = {
    "IANA allocation": ("2001",),
    "RIPE": ("2a00", "2a01", "2a02", "2a03", "2a04", "2a05", "2a06"),
    "APNIC": ("2400", "2401", "2402", "2403", "2404", "2405", "2406", "2407"),
    "ARIN": ("2600", "2601", "2602", "2603", "2604", "2605", "2606", "2607"),
    "LACNIC": ("2800", "2801", "2802", "2803"),
    "AFRINIC": ("2c00", "2c01"),
}
# Countries of the largest operators.
COUNTRY_HINTS = {
    "Hetzner": "DE", "OVH": "FR", "Scaleway": "FR", "Vultr": "US", "DigitalOcean": "US", "Linode": "US", "Amazon AWS": "US",
    "Google Cloud": "US", "Microsoft Azure": "US", "Cloudflare": "US", "GitHub": "US", "Meta": "US", "Akamai": "US", "Fastly": "US",
}

# Public suffixes of two labels.
TWO_PART_SUFFIXES = ("co.uk", "com.tr", "co.jp", "com.au", "com.br", "co.in", "org.uk", "net.tr", "gov.uk", "ac.uk", "com.cn", "edu.tr")

# Web attack patterns (title, category, weight, pattern).
WEB_PATTERNS = (
    ("SQL injection: union select", "sqli", 40, r"(?i)\bunion\b[\s/*]+\bselect\b"),
    ("SQL injection: tautology", "sqli", 35, r"""(?i)(\bor\b|\band\b)\s*['"]?\s*\d+\s*=\s*\d+"""),
    ("SQL injection: time based", "sqli", 45, r"(?i)\b(sleep|benchmark|pg_sleep|waitfor\s+delay)\s*\("),
    ("SQL injection: metadata access", "sqli", 40, r"(?i)information_schema|sysobjects|@@version|table_name"),
    ("SQL injection: stacked query", "sqli", 30, r"(?i);\s*(drop|insert|update|delete)\s+"),
    ("Cross-site scripting: script tag", "xss", 35, r"(?i)<\s*script[\s>]|<\s*/\s*script\s*>"),
    ("Cross-site scripting: event handler", "xss", 30, r"(?i)\bon(error|load|mouseover|focus|click)\s*="),
    ("Cross-site scripting: javascript scheme", "xss", 25, r"(?i)javascript\s*:|data:text/html"),
    ("Path traversal", "lfi", 40, r"(?i)(\.\./){2,}|(\.\.\\){2,}|%2e%2e[/%5c]"),
    ("Local file access", "lfi", 45, r"(?i)/etc/(passwd|shadow|hosts)|boot\.ini|win\.ini"),
    ("PHP wrapper abuse", "lfi", 45, r"(?i)php://(filter|input)|expect://|zip://"),
    ("Command injection", "cmdi", 45, r"(?i)[;|`]\s*(cat|wget|curl|nc|bash|sh|powershell|whoami|id)\b"),
    ("Command injection: shell substitution", "cmdi", 40, r"\$\(.*\)|`[^`]+`"),
    ("Log4Shell / JNDI lookup", "rce", 60, r"(?i)\$\{jndi:(ldap|rmi|dns|iiop)"),
    ("Server-side template injection", "rce", 40, r"(?i)\{\{.*(config|self|__class__|globals).*\}\}"),
    ("Server-side request forgery", "ssrf", 30, r"(?i)(url|redirect|next|dest|target)=(https?%3a|https?:)//(127\.0\.0\.1|localhost|169\.254|\[::1\])"),
    ("Deserialization payload", "rce", 45, r'(?i)rO0AB|aced0005|O:\d+:"'),
    ("Web shell access", "webshell", 50, r"(?i)(c99|r57|wso|b374k|shell|cmd)\.(php|asp|aspx|jsp)\b"),
    ("XML external entity", "xxe", 45, r"(?i)<!ENTITY\s+\S+\s+SYSTEM"),
    ("NoSQL injection", "sqli", 35, r"(?i)\$where|\$ne\s*:|\$regex\s*:"),
)
SCANNER_AGENTS = r"(?i)sqlmap|nikto|nmap|acunetix|nessus|masscan|dirbuster|gobuster|wfuzz|burp|zaproxy|havij|w3af|metasploit|hydra|feroxbuster|ffuf"
EXECUTABLE_EXTENSIONS = r"(?i)\.(exe|dll|scr|bat|cmd|ps1|vbs|jar|hta|msi|com|pif|apk|elf|bin)(\?|$)"

# Brands that look-alike domains imitate, in order of preference.
BRANDS = (
    "google.com", "gmail.com", "youtube.com", "facebook.com", "instagram.com", "microsoft.com", "outlook.com", "office.com",
    "live.com", "windows.com", "apple.com", "icloud.com", "amazon.com", "netflix.com", "paypal.com", "yahoo.com", "twitter.com",
    "linkedin.com", "dropbox.com", "adobe.com", "whatsapp.com", "telegram.org", "steamcommunity.com", "github.com",
    "wetransfer.com", "docusign.com", "chase.com", "wellsfargo.com", "bankofamerica.com", "hsbc.com", "santander.com", "binance.com",
)

# Ransomware file endings and note names.
RANSOM_ENDINGS = (
    ".locked", ".encrypted", ".crypt", ".crypto", ".enc", ".locky", ".cerber", ".zepto", ".odin", ".wncry", ".wcry", ".ryk", ".ryuk",
    ".conti", ".lockbit", ".revil", ".sodinokibi", ".darkside", ".blackcat", ".hive", ".avos", ".basta", ".royal", ".akira",
    ".phobos", ".dharma", ".makop", ".mallox", ".stop", ".djvu",
)
RANSOM_NOTES = (
    "readme.txt", "read_me.txt", "how_to_decrypt.txt", "decrypt_instructions", "restore_files", "recovery.txt",
    "how_to_back_files", "!!!readme!!!", "readme_for_decrypt", "your_files", "recover_files", "unlock_files",
)

# First bytes of files (bytes, type, category), first match wins.
FILE_MAGICS = (
    (b"MZ", "exe", "executable"),
    (b"\x7fELF", "elf", "executable"),
    (b"\xca\xfe\xba\xbe", "class", "executable"),
    (b"\xcf\xfa\xed\xfe", "macho", "executable"),
    (b"\xfe\xed\xfa\xce", "macho", "executable"),
    (b"dex\n", "dex", "executable"),
    (b"%PDF", "pdf", "document"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "ole", "document"),
    (b"PK\x03\x04", "zip", "archive"),
    (b"Rar!\x1a\x07", "rar", "archive"),
    (b"7z\xbc\xaf\x27\x1c", "7z", "archive"),
    (b"\x1f\x8b\x08", "gz", "archive"),
    (b"BZh", "bz2", "archive"),
    (b"\xfd7zXZ", "xz", "archive"),
    (b"\x89PNG\r\n\x1a\n", "png", "image"),
    (b"\xff\xd8\xff", "jpg", "image"),
    (b"GIF87a", "gif", "image"),
    (b"GIF89a", "gif", "image"),
    (b"BM", "bmp", "image"),
    (b"RIFF", "riff", "media"),
    (b"\x00\x00\x01\xba", "mpg", "media"),
    (b"ID3", "mp3", "media"),
    (b"OggS", "ogg", "media"),
    (b"SQLite format 3", "sqlite", "data"),
    (b"-----BEGIN", "pem", "credential"),
    (b"<?xml", "xml", "text"),
    (b"<!DOCTYPE html", "html", "text"),
    (b"<html", "html", "text"),
    (b"#!/", "script", "script"),
)

# Names within zip containers (name, type, category), first match wins.
ZIP_SUBTYPES = (
    ("word/", "docx", "document"),
    ("xl/", "xlsx", "document"),
    ("ppt/", "pptx", "document"),
    ("META-INF/MANIFEST", "jar", "executable"),
    ("AndroidManifest", "apk", "executable"),
    ("vbaProject.bin", "docm", "document"),
)

# Weights of severities and confidences in risk scores.
RISK_WEIGHTS = {"critical": 0.42, "high": 0.24, "medium": 0.10, "low": 0.035, "info": 0.0}
CONFIDENCE = {"high": 1.0, "medium": 0.75, "low": 0.5}
HOST_WEIGHTS = {"critical": 40, "high": 20, "medium": 8, "low": 3, "info": 0}
