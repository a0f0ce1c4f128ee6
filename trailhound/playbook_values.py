"""Response playbooks. Commands are carried as text and never executed.
"""

# --- Fixed values: playbooks --------------------------------------------------------------------
# (key, id, title, severity, tactic, technique, detection method, verification)
PLAYBOOKS = [
    ("brute_force_attack", "SOC-IR-001", "Brute Force / Password Spraying Attack", "HIGH",
     "TA0006 - Credential Access", "T1110 - Brute Force",
     "Multiple failed logins (Event ID 4625) from same IP",
     "Monitor failed login count for next 30 minutes - should drop to normal levels"),
    ("suspicious_powershell", "SOC-IR-002", "Suspicious PowerShell Execution - Potential Malware", "CRITICAL",
     "TA0002 - Execution", "T1059.001 - PowerShell",
     "PowerShell with encoded commands, download cradle, or obfuscation",
     "No new PowerShell processes with suspicious arguments"),
    ("privilege_escalation", "SOC-IR-003", "Privilege Escalation Detected", "CRITICAL",
     "TA0004 - Privilege Escalation", "T1068 - Exploitation for Privilege Escalation",
     "Special privileges assigned (Event ID 4672) or sensitive privilege use",
     "Run: whoami /priv on affected hosts - should show expected privileges only"),
    ("lateral_movement", "SOC-IR-004", "Lateral Movement Detected", "CRITICAL",
     "TA0008 - Lateral Movement", "T1021 - Remote Services",
     "PsExec, WMIC, WinRM, or other remote execution tools",
     "Monitor for unexpected network connections and remote executions for next 24 hours"),
    ("data_exfiltration", "SOC-IR-005", "Potential Data Exfiltration", "CRITICAL",
     "TA0010 - Exfiltration", "T1048 - Exfiltration Over Alternative Protocol",
     "Large outbound data transfers, unusual destinations",
     "Network traffic baseline restored to normal levels"),
    ("malware_infection", "SOC-IR-006", "Malware / Ransomware Infection", "CRITICAL",
     "TA0040 - Impact", "T1486 - Data Encrypted for Impact",
     "Unusual file extensions, ransom notes, high CPU usage",
     "System clean after full scan; no encryption activity detected"),
    ("port_scan", "SOC-IR-007", "Port Scan / Network Reconnaissance", "MEDIUM",
     "TA0043 - Reconnaissance", "T1046 - Network Service Scanning",
     "Multiple connection attempts to different ports",
     "No further scan traffic from blocked IP"),
    ("generic_compromise", "SOC-IR-008", "Security Incident - General Compromise", "HIGH",
     "Unknown", "Unknown", "SOC investigation findings",
     "All indicators of compromise eliminated"),
]

# (playbook, step, action, command, platform, estimated time)
CONTAINMENT_STEPS = [
    ("brute_force_attack", 1, "Identify attacking IP addresses",
     "Get-EventLog -LogName Security -InstanceId 4625 | Group-Object -Property ReplacementStrings | Select-Object -First 20 | Format-Table",
     "windows", "2 minutes"),
    ("brute_force_attack", 2, "Block attacking IPs at network perimeter",
     "New-NetFirewallRule -DisplayName 'SOC_Block_BruteForce' -Direction Inbound -RemoteAddress <ATTACKER_IP> -Action Block",
     "windows", "5 minutes"),
    ("brute_force_attack", 3, "Check for successful logins from attacker IP",
     "Get-EventLog -LogName Security -InstanceId 4624 | Where-Object {$_.ReplacementStrings[5] -eq '<ATTACKER_IP>'} | Select-Object -First 10",
     "windows", "3 minutes"),
    ("brute_force_attack", 4, "Reset passwords for compromised accounts",
     "net user <USERNAME> /domain /reset-password", "windows", "5 minutes per account"),
    ("brute_force_attack", 5, "Enable account lockout policy",
     "net accounts /lockoutthreshold:5 /lockoutduration:30 /lockoutwindow:30", "windows", "5 minutes"),
    ("brute_force_attack", 6, "Enable MFA for affected accounts",
     "Connect to Azure AD / Identity Provider console", "cloud", "15 minutes"),
    ("suspicious_powershell", 1, "Isolate affected endpoint immediately",
     "New-NetFirewallRule -DisplayName 'Isolate_Host' -Direction Outbound -Action Block -RemoteAddress Any",
     "windows", "2 minutes"),
    ("suspicious_powershell", 2, "Capture full PowerShell command line arguments",
     "Get-WinEvent -FilterHashtable @{LogName='Microsoft-Windows-PowerShell/Operational'; ID=4104} | Where-Object {$_.Message -like '*<SUSPICIOUS_COMMAND>*'} | Select-Object -First 50 | Format-List",
     "windows", "5 minutes"),
    ("suspicious_powershell", 3, "Decode base64 PowerShell commands",
     "[System.Text.Encoding]::UTF8.GetString([System.Convert]::FromBase64String('<BASE64_STRING>'))",
     "windows", "3 minutes"),
    ("suspicious_powershell", 4, "Check for network connections from PowerShell",
     "Get-NetTCPConnection | Where-Object {$_.OwningProcess -eq (Get-Process -Name powershell).Id}",
     "windows", "3 minutes"),
    ("suspicious_powershell", 5, "Scan for malware using EDR/AV",
     "Start-MpScan -ScanType QuickScan", "windows", "10 minutes"),
    ("suspicious_powershell", 6, "Collect forensic artifacts",
     "Get-Process | Export-Csv -Path C:\\temp\\processes.csv; Get-Service | Export-Csv -Path C:\\temp\\services.csv",
     "windows", "10 minutes"),
    ("privilege_escalation", 1, "Identify escalated account and affected systems",
     "Get-EventLog -LogName Security -InstanceId 4672 | Select-Object -First 20 TimeGenerated, User, Message",
     "windows", "3 minutes"),
    ("privilege_escalation", 2, "Force logout of suspicious user sessions",
     "logoff <SESSION_ID>; or: Get-Process -IncludeUserName | Where-Object UserName -like '*<USER>*' | Stop-Process -Force",
     "windows", "3 minutes"),
    ("privilege_escalation", 3, "Disable compromised accounts",
     "Disable-ADAccount -Identity <USERNAME>", "windows", "2 minutes"),
    ("privilege_escalation", 4, "Check for new admin account creation",
     "Get-LocalGroupMember -Group 'Administrators' | Where-Object {$_.Name -notlike '*Administrator*'}",
     "windows", "3 minutes"),
    ("privilege_escalation", 5, "Review scheduled tasks for persistence",
     "Get-ScheduledTask | Where-Object {$_.State -ne 'Disabled'} | Get-ScheduledTaskInfo",
     "windows", "5 minutes"),
    ("privilege_escalation", 6, "Check for unauthorized service creation",
     "Get-WmiObject -Class Win32_Service | Where-Object {$_.StartMode -eq 'Auto' -and $_.PathName -like '*temp*'}",
     "windows", "5 minutes"),
    ("lateral_movement", 1, "Identify source and destination hosts",
     "Get-WinEvent -FilterHashtable @{LogName='Security'; ID=4688} | Where-Object {$_.Message -like '*psexec*' -or $_.Message -like '*wmic*'}",
     "windows", "5 minutes"),
    ("lateral_movement", 2, "Isolate affected source host",
     "New-NetFirewallRule -DisplayName 'Containment' -Direction Outbound -Action Block -RemoteAddress Any",
     "windows", "3 minutes"),
    ("lateral_movement", 3, "Block PsExec and WMIC across environment",
     "Set-ItemProperty -Path 'HKLM:\\SOFTWARE\\Policies\\Microsoft\\Windows\\System' -Name 'EnablePSExec' -Value 0; Set-ItemProperty -Path 'HKLM:\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Policies\\System' -Name 'EnableWMIC' -Value 0",
     "windows", "5 minutes"),
    ("lateral_movement", 4, "Check for credential dumping tools",
     "Get-Process | Where-Object {$_.ProcessName -match 'mimikatz|procdump|lsass'}", "windows", "3 minutes"),
    ("lateral_movement", 5, "Force password reset for potentially compromised accounts",
     "Get-ADUser -Filter * | Where-Object {$_.LastLogonDate -gt (Get-Date).AddDays(-7)} | Set-ADAccountPassword -Reset",
     "windows", "15 minutes"),
    ("data_exfiltration", 1, "Identify destination IPs and data volume",
     "Get-NetTCPConnection | Group-Object RemoteAddress | Select-Object Name, Count | Sort-Object Count -Descending",
     "windows", "5 minutes"),
    ("data_exfiltration", 2, "Block outbound traffic to suspicious destinations",
     "New-NetFirewallRule -DisplayName 'Block_Exfil' -Direction Outbound -RemoteAddress <SUSPICIOUS_IP> -Action Block",
     "windows", "3 minutes"),
    ("data_exfiltration", 3, "Identify what data was accessed/exfiltrated",
     "Get-WinEvent -FilterHashtable @{LogName='Security'; ID=4663} | Where-Object {$_.Message -like '*Read*' -or $_.Message -like '*Copy*'} | Select-Object -First 100",
     "windows", "10 minutes"),
    ("data_exfiltration", 4, "Check for compressed/archived data",
     "Get-ChildItem -Path C:\\ -Recurse -Include *.zip,*.7z,*.rar -ErrorAction SilentlyContinue | Where-Object {$_.LastWriteTime -gt (Get-Date).AddHours(-24)}",
     "windows", "10 minutes"),
    ("data_exfiltration", 5, "Preserve firewall and proxy logs for investigation",
     "wevtutil epl Microsoft-Windows-WindowsFirewall-Firewall%4Operational.evtx C:\\temp\\firewall_logs.evtx",
     "windows", "5 minutes"),
    ("malware_infection", 1, "IMMEDIATE ISOLATION - Disable network interface",
     "Get-NetAdapter | Disable-NetAdapter -Confirm:$false", "windows", "1 minute"),
    ("malware_infection", 2, "Disable network shares",
     "Stop-Service LanmanServer -Force; Set-Service LanmanServer -StartupType Disabled",
     "windows", "2 minutes"),
    ("malware_infection", 3, "Kill suspicious processes",
     "Get-Process | Where-Object {$_.CPU -gt 50 -or $_.ProcessName -like '*ransom*'} | Stop-Process -Force",
     "windows", "3 minutes"),
    ("malware_infection", 4, "Disable all scheduled tasks",
     "Get-ScheduledTask | Disable-ScheduledTask", "windows", "3 minutes"),
    ("malware_infection", 5, "Initiate incident response team",
     "Contact SOC and CIRT immediately", "process", "1 minute"),
    ("port_scan", 1, "Identify scanning source IP",
     "Get-NetTCPConnection | Group-Object RemoteAddress | Where-Object {$_.Count -gt 100} | Select-Object Name, Count",
     "windows", "3 minutes"),
    ("port_scan", 2, "Block scanning IP",
     "New-NetFirewallRule -DisplayName 'Block_PortScan' -Direction Inbound -RemoteAddress <SCANNER_IP> -Action Block",
     "windows", "2 minutes"),
    ("port_scan", 3, "Check if scanner successfully accessed any service",
     "Get-NetTCPConnection | Where-Object {$_.RemoteAddress -eq '<SCANNER_IP>' -and $_.State -eq 'Established'}",
     "windows", "3 minutes"),
    ("port_scan", 4, "Review vulnerable services on targeted ports",
     "Get-Service | Where-Object {$_.Status -eq 'Running'} | Select-Object Name, DisplayName",
     "windows", "5 minutes"),
    ("generic_compromise", 1, "Document all findings and indicators",
     "Export investigation results to CSV/JSON for evidence", "process", "10 minutes"),
    ("generic_compromise", 2, "Isolate affected systems", "Network isolation or host blocking",
     "network", "5 minutes"),
    ("generic_compromise", 3, "Preserve forensic artifacts", "Capture memory, logs, and disk images",
     "forensics", "30 minutes"),
    ("generic_compromise", 4, "Reset compromised credentials", "Force password reset for affected accounts",
     "identity", "10 minutes"),
]

# (playbook, step): another way to take a containment step
STEP_ALTERNATIVES = {
    ("brute_force_attack", 2): "Contact network team to block at firewall level",
}

# (playbook, eradication steps, recovery steps, post-incident actions)
FOLLOW_UP_STEPS = [
    ("brute_force_attack",
     ["Review all accounts for unauthorized access", "Analyze source IP geolocation and reputation",
      "Check for malware on compromised endpoints"],
     ["Verify no persistent access established", "Monitor for follow-up attacks", "Document incident timeline"],
     ["Update firewall rules permanently", "Implement geo-blocking if applicable",
      "Conduct password policy review"]),
    ("suspicious_powershell",
     ["Kill suspicious PowerShell processes", "Remove any downloaded files",
      "Delete scheduled tasks created by PowerShell", "Clear PowerShell history"],
     ["Restore from clean backup if system compromised", "Reinstall endpoint if heavily infected",
      "Apply Windows updates"],
     ["Enable PowerShell logging (ScriptBlock, Module, Transcription)", "Configure AppLocker or WDAC",
      "Restrict PowerShell to constrained language mode"]),
    ("privilege_escalation",
     ["Remove malicious users from privileged groups", "Delete unauthorized scheduled tasks",
      "Remove malicious services", "Apply security patches for known escalation vectors"],
     ["Reset all passwords for affected accounts", "Enable LAPS for local admin password management",
      "Review and audit all privilege assignments"],
     ["Implement Privileged Access Workstations (PAWs)", "Enable Just-In-Time (JIT) access",
      "Deploy PAM solution"]),
    ("lateral_movement",
     ["Remove remote management tools if not needed", "Clean up any created services or scheduled tasks",
      "Disable unused administrative shares (C$, ADMIN$)"],
     ["Rebuild compromised hosts from clean images", "Rotate all Kerberos tickets (KRBTGT)",
      "Reset machine account passwords"],
     ["Implement network segmentation", "Deploy EDR with lateral movement detection",
      "Restrict administrative access using JIT"]),
    ("data_exfiltration",
     ["Isolate affected data sources", "Revoke compromised credentials",
      "Rotate database credentials if applicable"],
     ["Assess data breach impact", "Notify legal and compliance teams",
      "Prepare breach notification if PII involved"],
     ["Implement DLP solution", "Enable data classification and labeling",
      "Review and enhance network monitoring"]),
    ("malware_infection",
     ["Take affected host offline completely", "Format and reinstall operating system",
      "Restore from clean backups", "Scan all connected network drives"],
     ["Restore data from offline backups", "Apply all security patches", "Enhance endpoint protection"],
     ["Review backup strategy (offline, immutable)", "Implement application whitelisting",
      "Deploy endpoint detection and response (EDR)"]),
    ("port_scan",
     ["Close unnecessary open ports", "Implement port knocking or allowlisting",
      "Apply patches to vulnerable services"],
     ["Monitor for follow-up attacks", "Adjust IDS/IPS rules"],
     ["Implement network segmentation", "Deploy honeypots for early detection"]),
    ("generic_compromise",
     ["Remove malware/tools from system", "Apply security patches", "Close attack vectors"],
     ["Restore from clean backup", "Monitor for re-infection", "Update incident documentation"],
     ["Conduct post-mortem analysis", "Update security controls", "Enhance monitoring rules"]),
]
